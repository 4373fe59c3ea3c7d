"""Main text of web pages, with a suffix array over the pages of a host.

1. A page becomes blocks: text between block-level tags, each with the path of its enclosing elements. Character
   references are decoded, white space runs become one space; scripts, styles, comments and markup are no text.
2. The words of all blocks of the pages of one host are put one page after the other, with a mark of its own between
   pages, and their suffixes are sorted by prefix doubling to a depth of ``DEPTH`` words. Neighbours that agree so far and
   come from enough distinct pages cover their words: the union of these is every substring of that length or more that
   the pages share. Enough is ``MANY_PAGES``, on a small host half of its distinct pages, and ``LEAST_PAGES`` at least.
3. On pages without an article or main element, a path most of whose words on the host are covered is template (menus,
   notices, adverts, footers): covered runs on it are removed, unique runs stay.
4. Inside an article or main element, copies of an article and quotations are no boilerplate. A substring counts there by
   the distinct texts it stands in, told by the heads of the three longest other blocks of the page, so that copies count
   once; it must also stand on ``SITE_SHARE`` of the host's pages, as a line that some articles have in common is their own;
   and only where such substrings cover nearly all of a block are they removed.
5. Elements that are no article by their meaning are left out: nav, footer, aside and the like, roles, and classes or ids
   all of whose parts say so; a form, unless it wraps most of the page's words. Where a page has an article or main
   element, so is what stands outside it. This also serves hosts with too few pages to compare.

A host of over ``GROUP_PAGES`` distinct pages or ``GROUP_CHARS`` is not sorted in one task. Its pages are parsed into a
written table, and its substrings of ``DEPTH`` words go by 64-bit digests: a counting filter of a fixed size
leaves out those that are on too few pages for certain, tasks reduce the others to as many distinct pages and texts as the bound asks for, these are
counted over the whole host, and a second count gives the coverage of its paths. Bounds are the same on either way; every
page is processed whole.

Defined results: null and empty html give the empty text and no characters; a null url belongs to a host of its own; of
repeated rows each gets its text (they count as one page where substrings are compared); an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entwyne.llm.common import discard, materialise
from entwyne.llm.linedup import SEGMENT, slots_for

GROUP_PAGES, GROUP_CHARS, DEPTH = 128, 8_000_000, 8
#: Distinct pages, or inside content distinct texts, that must hold a substring.
MANY_PAGES, LEAST_PAGES = 8, 3
#: Share of a path's words that makes it template; share of a block of content that must be covered, and of the host's pages
#: that must hold what covers it; words of a head.
TEMPLATE_SHARE, CONTENT_SHARE, SITE_SHARE, HEAD = 0.5, 0.8, 0.25, 6
#: Boilerplate substrings of large hosts held at a time (8 bytes each); with more, hosts are taken in several turns.
BROADCAST_WINDOWS, SLOTS_PER_PAGE, HELD_OCCURRENCES = 2_000_000, 512, 1_000_000
#: Hosts of several groups that are sent to all executors (some 100 bytes each); more are joined by a shuffle.
BROADCAST_HOSTS = 100_000
#: Large hosts whose template paths are held at a time (some tens each).
HOSTS_PER_TURN = 20_000

# Elements by their meaning in HTML, and words of class, id and role that say what a part is.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_RAW = frozenset("script style noscript template textarea iframe svg math canvas object video audio select title noframes noembed".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NO_CONTENT = frozenset("nav footer aside menu dialog button head dir".split())
_CONTENT = frozenset("article main".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus footer masthead pager pagination widget banner disclaimer".split())
#: Elements that end an open paragraph or list item of the same kind.
_SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?][^>]*>)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def _says_no_content(attrs: str) -> bool:
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            for token in value.split():
                parts = [w for w in re.split(r"[^a-z]+", token) if w]
                if parts and _WORDS.issuperset(parts):
                    return True
        elif name == "role" and value.strip() in _ROLES:
            return True
    return False


class Block:
    """Text with one space between words, its words, and where it stands."""

    __slots__ = ("content", "form", "n", "no_content", "path", "text")

    def __init__(self, text: str, path: str, content: bool, no_content: bool, form: int = 0):
        self.text, self.n, self.path, self.content, self.no_content, self.form = text, text.count(" ") + 1, path, content, no_content, form

    @property
    def words(self) -> list[str]:
        return self.text.split(" ")


def _has_content(own: list[Block]) -> bool:
    return any(b.content and not b.no_content for b in own)


def _drop_forms(own: list[Block]) -> None:
    """A form is no content, unless it wraps most of the words that are left."""
    in_form: dict[int, int] = defaultdict(int)
    for b in own:
        if not b.no_content:
            in_form[b.form] += b.n
    whole = sum(in_form.values())
    for b in own:
        if b.form and 2 * in_form[b.form] <= whole:
            b.no_content = True


def blocks(page: str | None) -> list[Block]:
    """The page's blocks in order."""
    text = page or ""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, str, int]] = []  # tag, inside content, no content, path, outermost form
    held: list[str] = []
    is_open: dict[str, int] = defaultdict(int)

    def close(i: int):
        for gone in stack[i:]:
            is_open[gone[0]] -= 1
        del stack[i:]

    def flush():
        if held:
            words = _html.unescape("".join(held)).split()
            held.clear()
            if words:
                _, content, none, path, form = stack[-1] if stack else ("", False, False, "", 0)
                out.append(Block(" ".join(words), path, content, none, form))

    at, n, forms = 0, len(text), 0
    while at < n:
        m = _TAG.search(text, at)
        if m is None:
            held.append(text[at:])
            break
        if m.start() > at:
            held.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _BLOCK:
                flush()
                for i in range(len(stack) - 1, -1, -1) if is_open[tag] else ():
                    if stack[i][0] == tag:
                        close(i)
                        break
            continue
        if tag in _RAW:
            if tag in _BLOCK:
                flush()
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, at)
                at = end.end() if end else n
            held.append(" ")
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag not in _BLOCK:
            continue
        flush()
        if tag in _VOID:
            continue
        if tag in _SELF_CLOSING:
            for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] not in _SELF_CLOSING:
                    break
        elif stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        _, content, none, path, form = stack[-1] if stack else ("", False, False, "", 0)
        if tag == "form" and not form:
            forms += 1
            form = forms
        if tag in _CONTENT and not content:
            content, none = True, False  # an element left open in front of it doesn't swallow the article
        none = none or tag in _NO_CONTENT or (tag == "header" and not content) or bool(m[3] and _says_no_content(m[3]))
        css = re.search(r"class\s*=\s*[\"']?([\w-]+)", m[3]) if m[3] else None
        stack.append((tag, content, none, f"{path}/{tag}" + (f".{css[1]}" if css else "") if len(path) < 300 else path, form))
        is_open[tag] += 1
    flush()
    if forms:
        _drop_forms(out)
    return out


def suffix_ranks(ids: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix among all by its first ``depth`` (a power of two) tokens; equal prefixes share a rank."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    length = 1
    while length < depth:
        ahead = np.zeros_like(rank)
        ahead[:-length] = rank[length:]
        rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        length *= 2
    return rank


def _held(rank: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Of each suffix how many distinct labels hold its prefix; negative labels don't count."""
    order = np.lexsort((label, rank))
    r, p = rank[order], label[order]
    first = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])]) & (p >= 0)
    return np.bincount(r, weights=first, minlength=int(r[-1]) + 1)[rank]


def _cover(rank: np.ndarray, label: np.ndarray, least: int, depth: int) -> np.ndarray:
    """Which tokens lie in a prefix that ``least`` distinct labels hold."""
    return _spread(_held(rank, label) >= least, len(rank), depth)


def _spread(starts: np.ndarray, n: int, depth: int = DEPTH) -> np.ndarray:
    whole = np.zeros(n + 1, np.int64)
    start = np.flatnonzero(starts)
    start = start[start + depth <= n]
    np.add.at(whole, start, 1)
    np.add.at(whole, start + depth, -1)
    return np.cumsum(whole)[:n] > 0


def shared(ids: np.ndarray, page: np.ndarray, least: int, depth: int = DEPTH) -> np.ndarray:
    """Which tokens lie in a substring of ``depth`` tokens or more that ``least`` distinct pages hold.

    ``ids`` has a negative number of its own after each page, so that no substring reaches into the next.
    """
    return _cover(suffix_ranks(ids, depth), page, least, depth) if len(ids) >= depth else np.zeros(len(ids), bool)


def around(own: list[Block]) -> np.ndarray:
    """Per word three digests that tell its text from others (heads of the longest other content blocks); -1 for none."""
    longest = sorted((-b.n, k) for k, b in enumerate(own) if b.content and not b.no_content)[:4]
    heads = [(k, xxhash.xxh3_64_intdigest(" ".join(own[k].text.split(" ", HEAD)[:HEAD])) >> 1) for _, k in longest]
    out = np.full((3, sum(b.n for b in own)), -1, np.int64)
    at = 0
    for k, b in enumerate(own):
        if b.content and not b.no_content:
            for j, h in enumerate([h for i, h in heads if i != k][:3]):
                out[j, at : at + b.n] = h
        at += b.n
    return out


def _rows(own: list[Block], mark: np.ndarray) -> list[np.ndarray]:
    return np.split(mark, np.cumsum([b.n for b in own])[:-1]) if own else []


def _count_paths(own: list[Block], covered: np.ndarray, hit: dict, total: dict, key=lambda path: path) -> None:
    """Words by path on a page without an article or main element; where it has one, its paths decide nothing."""
    if not _has_content(own):
        for b, row in zip(own, _rows(own, covered), strict=True):
            total[key(b.path)] += b.n
            hit[key(b.path)] += int(row.sum())


def _text(own: list[Block], covered: np.ndarray, inside: np.ndarray, is_template) -> str:
    """The text of a page from its words covered by any pages and by distinct texts."""
    has_content = _has_content(own)
    lines = []
    for b, mark, common in zip(own, _rows(own, covered), _rows(own, inside), strict=True):
        if b.no_content or (has_content and not b.content):
            continue
        if b.content:
            gone = common if common.sum() >= CONTENT_SHARE * b.n else None
        else:
            gone = mark if is_template(b.path) else None
        if gone is None or not gone.any():
            lines.append(b.text)
        elif not gone.all():
            lines.append(" ".join(w for w, c in zip(b.words, gone.tolist(), strict=True) if not c))
    return "\n".join(lines)


def extract(pages: list[str | None]) -> list[str]:
    """Main texts of all pages of one host."""
    own = [blocks(p) for p in pages]
    vocabulary: dict[str, int] = {}
    ids: list[int] = []
    page: list[int] = []
    same: dict[str, int] = {}
    for k, (text, bs) in enumerate(zip(pages, own, strict=True)):
        number = same.setdefault(text or "", k)
        for b in bs:
            ids += [vocabulary.setdefault(w, len(vocabulary)) for w in b.words]
        ids.append(-1 - k)
        page += [number] * (len(ids) - len(page))
    n = len(ids)
    covered, inside = np.zeros(n, bool), np.zeros(n, bool)
    if len(same) >= LEAST_PAGES and n >= DEPTH:
        rank = suffix_ranks(np.array(ids, np.int64), DEPTH)
        least = min(MANY_PAGES, max(LEAST_PAGES, -(-len(same) // 2)))
        covered = _cover(rank, np.array(page, np.int64), least, DEPTH)
        labels = np.concatenate([np.pad(around(bs), ((0, 0), (0, 1)), constant_values=-1) for bs in own], axis=1)
        sites = np.repeat(np.arange(len(own)), [sum(b.n for b in bs) + 1 for bs in own])
        wide = _held(rank, np.where((labels >= 0).any(axis=0), sites, -1)) >= SITE_SHARE * len(own)
        for label in labels:
            inside |= _spread((_held(rank, label) >= least) & wide, n, DEPTH)
    places, at = [], 0
    hit, total = defaultdict(int), defaultdict(int)
    for bs in own:
        size = sum(b.n for b in bs)
        places.append((covered[at : at + size], inside[at : at + size]))
        _count_paths(bs, places[-1][0], hit, total)
        at += size + 1
    template = {p for p in total if hit[p] >= TEMPLATE_SHARE * total[p]}
    return [_text(bs, *marks, template.__contains__) for bs, marks in zip(own, places, strict=True)]


_BASE = 0x9E3779B97F4A7C15
_LETTERS = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def digests(own: list[Block], host: int) -> np.ndarray:
    """64-bit digests of the page's substrings of ``DEPTH`` words, by place; the host is part of them.

    A substring's digest is the difference of two prefix sums over its letters, moved to the same place.
    """
    raw = np.frombuffer(" ".join(b.text for b in own).encode("utf-8", "surrogatepass"), np.uint8)
    spaces = np.flatnonzero(raw == 32)
    if len(spaces) + 1 < DEPTH:
        return np.zeros(0, np.int64)
    start, end = np.concatenate([[0], spaces + 1])[: 1 - DEPTH], np.concatenate([spaces, [len(raw)]])[DEPTH - 1 :]
    power, inverse = _power(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTERS[raw] * power[: len(raw)], out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start] + np.uint64(host & 0xFFFFFFFFFFFFFFFF)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


_PARSED = "page_id long, url string, host long, least int, sites long, page long, plain boolean, texts array<string>, paths array<string>, flags array<tinyint>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 32):
            part = batch.slice(at, 32)
            htmls = part.column("html").to_pylist()
            own = [blocks(h) for h in htmls]
            yield pa.RecordBatch.from_arrays([
                *[part.column(c) for c in ("page_id", "url", "host", "least", "sites")], pa.array([xxhash.xxh3_64_intdigest(h or "") >> 1 for h in htmls], pa.int64()), pa.array([not _has_content(bs) for bs in own], pa.bool_()),
                pa.array([[b.text for b in bs] for bs in own], pa.list_(pa.string())), pa.array([[b.path for b in bs] for bs in own], pa.list_(pa.string())),
                pa.array([[b.content + 2 * b.no_content for b in bs] for bs in own], pa.list_(pa.int8())),
            ], ["page_id", "url", "host", "least", "sites", "page", "plain", "texts", "paths", "flags"])


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches of parsed pages with (host, least, page, blocks, digests) of their rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            rows = []
            for host, least, page, texts, paths, flags in zip(*(part.column(c).to_pylist() for c in ("host", "least", "page", "texts", "paths", "flags")), strict=True):
                own = [Block(t, p, bool(f & 1), bool(f & 2)) for t, p, f in zip(texts, paths, flags, strict=True)]
                rows.append((host, least, page, own, digests(own, host)))
            yield part, rows


def _place(w: np.ndarray, slots: int) -> np.ndarray:
    return (w & np.int64(slots - 1)).astype(np.int64)


def _tally(slots: int):
    """Saturating counts of pages by place of their substrings' digests: never too low, so what stays below ``MANY_PAGES``
    is rare. Pages of a host with a lower bound count for more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, packer = np.zeros(slots, np.uint8), zstandard.ZstdCompressor(level=1)
        for _, rows in _pages(batches):
            found = [(np.unique(w), -(-MANY_PAGES // least)) for _, least, _, _, w in rows]
            at, back = np.unique(_place(np.concatenate([x for x, _ in found]), slots), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([np.full(len(x), k) for x, k in found]), minlength=len(at))
            tally[at] = np.minimum(tally[at] + counts, MANY_PAGES)
        step = min(SEGMENT, slots)
        for s in range(0, slots, step):
            if tally[s : s + step].any():
                yield pa.RecordBatch.from_arrays([pa.array([s // step], pa.int32()), pa.array([packer.compress(tally[s : s + step].tobytes())], pa.binary())], ["seg", "n"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opener, held = zstandard.ZstdDecompressor(), {}
    for batch in batches:
        for seg, n in zip(batch.column(0), batch.column(1), strict=True):
            own = np.frombuffer(opener.decompress(n.as_py()), np.uint8)
            held[seg.as_py()] = np.minimum(held[seg.as_py()] + own, MANY_PAGES) if seg.as_py() in held else own
    many = [np.packbits(v >= MANY_PAGES, bitorder="little").tobytes() for v in held.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(many, pa.binary())], ["seg", "many"])


def _frequent(pages: DataFrame, slots: int) -> bytes:
    """Packed filter of the digests that may be on enough pages."""
    step = min(SEGMENT, slots) // 8
    out = bytearray(slots // 8)
    parts = pages.mapInArrow(_tally(slots), "seg int, n binary")
    for row in parts.repartition(max(1, min(16, slots // SEGMENT)), "seg").mapInArrow(_merge, "seg int, many binary").toLocalIterator():
        out[row.seg * step : (row.seg + 1) * step] = row.many
    return bytes(out)


_MET = "host long, w long, kind byte, label long"
#: Kinds of rows that substrings are counted by: distinct pages, distinct texts by three heads, number of pages in content.
_PAGE, _SITES = 0, 4


def _reduced(held: list[np.ndarray]) -> pa.RecordBatch:
    """Of each substring the distinct pages and texts, as many as a bound can ask for, and on how many pages it is content."""
    w, kind, label, host = np.concatenate(held, axis=1)
    order = np.lexsort((label, kind, w))
    w, kind, label, host = (x[order] for x in (w, kind, label, host))
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (kind[1:] != kind[:-1])])
    fresh = new.copy()
    fresh[1:] |= label[1:] != label[:-1]
    nth = np.cumsum(fresh)
    keep = np.where(kind == _SITES, new, fresh & (nth - np.maximum.accumulate(np.where(new, nth, 0)) < MANY_PAGES))
    start = np.flatnonzero(new)
    label[start] = np.where(kind[start] == _SITES, np.add.reduceat((kind == _SITES).astype(np.int64), start), label[start])
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (host, w, kind.astype(np.int8), label)], ["host", "w", "kind", "label"])


def _occurrences(filter_):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n = np.frombuffer(filter_.value, np.uint8), [], 0
        for _, rows in _pages(batches):
            for host, _, page, own, w in rows:
                place = _place(w, 8 * len(seen))
                hit = np.flatnonzero((seen[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                if not len(hit):
                    continue
                labels = np.concatenate([np.full((1, len(hit)), page), around(own)[:, hit]])
                kind, at = np.nonzero(labels >= 0)
                content = np.unique(w[hit][(labels[1:] >= 0).any(axis=0)])
                held.append(np.stack([w[hit][at], kind, labels[kind, at], np.full(len(at), host)]))
                fixed = np.array([[_SITES], [0], [host]], np.int64).repeat(len(content), axis=1)
                held.append(np.concatenate([content[None], fixed]))
                n += len(at) + len(content)
            if n >= HELD_OCCURRENCES:
                yield _reduced(held)
                held, n = [], 0
        if held:
            yield _reduced(held)

    return run


def _marks(own: list[Block], w: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Words covered by any pages, and by distinct texts; ``known``: sorted digests of both."""
    n, out = sum(b.n for b in own), []
    for k in known:
        at = np.searchsorted(k, w)
        out.append(_spread(k[np.minimum(at, len(k) - 1)] == w if len(k) else np.zeros(len(w), bool), n))
    return out


def _path_key(host: int, path: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{host}{path}") >> 1


def _paths(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _pages(batches):
            hit, total = defaultdict(int), defaultdict(int)
            for host, _, _, own, w in rows:
                _count_paths(own, _marks(own, w, known.value)[0], hit, total, lambda path, host=host: _path_key(host, path))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(hit.values()), pa.int64()), pa.array(list(total.values()), pa.int64())], ["path", "hit", "total"])

    return run


def _texts(known, template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _pages(batches):
            texts = [_text(own, *_marks(own, w, known.value), lambda path, host=host: _path_key(host, path) in template.value) for host, _, _, own, w in rows]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def _large_hosts(rows: DataFrame, n_hosts: int, n_pages: int, windows: int) -> Iterator[DataFrame]:
    """Main texts of the pages of large hosts, in one turn or more."""
    context = rows.sparkSession.sparkContext
    parsed = materialise(rows.select("page_id", "url", "html", F.xxhash64("host").alias("host"), "least", "sites").mapInArrow(_parse, _PARSED), "parsed", compression="zstd")
    filter_ = context.broadcast(_frequent(parsed, slots_for(n_pages, SLOTS_PER_PAGE)))
    # A task has few rows of a substring and kind, so sets of them are small, and one shuffle brings them together.
    met = parsed.mapInArrow(_occurrences(filter_), _MET).groupBy("host", "w", "kind")
    met = met.agg(F.size(F.collect_set("label")).alias("n"), F.sum(F.when(F.col("kind") == _SITES, F.col("label")).otherwise(F.lit(0))).alias("total"))
    bounds = parsed.select("host", "least", "sites").distinct()
    met = met.join(F.broadcast(bounds) if n_hosts <= BROADCAST_HOSTS else bounds, "host")
    kind, enough = F.col("kind"), F.col("n") >= F.col("least")
    holds = lambda which, good: F.coalesce(F.max(F.when(which, good)), F.lit(False))
    inside = holds(kind.between(1, 3), enough) & holds(kind == _SITES, F.col("total") >= SITE_SHARE * F.col("sites"))
    counted = met.groupBy("host", "w").agg(holds(kind == _PAGE, enough).alias("any"), inside.alias("inside")).where(F.col("any") | F.col("inside"))
    counted = materialise(counted, "windows")
    turns = max(1, -(-counted.count() // windows), -(-n_hosts // HOSTS_PER_TURN))
    turn = F.pmod(F.xxhash64("host"), F.lit(turns))
    for k in range(turns):
        found = counted.where(turn == k).select("w", "any", "inside").toArrow()
        w = found.column("w").to_numpy()
        known = context.broadcast(tuple(np.sort(w[found.column(c).to_numpy()]) for c in ("any", "inside")))
        own = parsed.where(turn == k)
        covered = own.where("plain").mapInArrow(_paths(known), "path long, hit long, total long").groupBy("path").agg(F.sum("hit").alias("hit"), F.sum("total").alias("total"))
        template = context.broadcast({r.path for r in covered.where(F.col("hit") >= TEMPLATE_SHARE * F.col("total")).select("path").collect()})
        yield own.mapInArrow(_texts(known, template), _RESULT)
    discard(counted)


_RESULT = "page_id long, url string, text string, n_chars long"


def _group(table: pa.Table) -> pa.Table:
    texts = extract(table.column("html").to_pylist())
    return pa.table([table.column("page_id"), table.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, group_pages: int = GROUP_PAGES, broadcast_hosts: int = BROADCAST_HOSTS, windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    text = F.coalesce("html", F.lit(""))
    each = rows.select("host", F.xxhash64(text).alias("page"), F.char_length(text).cast("long").alias("chars"))
    each = each.groupBy("host", "page").agg(F.count(F.lit(1)).alias("rows"), F.sum("chars").alias("chars"))
    sizes = each.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"), F.sum("chars").alias("chars"))
    sizes = materialise(sizes.where((F.col("n") > group_pages) | (F.col("chars") > GROUP_CHARS)), "hosts")
    n_hosts, n_pages = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    large = sizes.select("host", F.least(F.lit(MANY_PAGES), F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("n") / 2))).cast("int").alias("least"), F.col("rows").alias("sites"))
    large = F.broadcast(large) if n_hosts <= broadcast_hosts else large
    out = (rows.join(large, "host", "left_anti") if n_hosts else rows).select("page_id", "url", "html", "host").groupBy("host").applyInArrow(_group, _RESULT)
    for own in _large_hosts(rows.join(large, "host"), n_hosts, n_pages, windows) if n_hosts else ():
        out = out.unionByName(own)
    return out
