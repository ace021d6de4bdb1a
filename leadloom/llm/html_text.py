"""HTML extraction: the main text of pages, by differencing each page with the page of the nearest URL of its host.

A page is read once into its text lines (a line is what a block element holds, references decoded and white space made one space). Pages of a host are ordered by
URL path; the nearest page of another content is the neighbour with the longer common path. The lines of the two are aligned by a longest common
subsequence (bit-parallel, so that a row of the table costs a few operations on long integers; divided after Hirschberg where the rows would take more than LCS_BITS), and lines
that both have are deleted: menus, notices, footers of a site are in both.

Two things temper this. Where the shared lines are four fifths (VERSIONS) or more of what a page would keep, the pair are versions of one article and nothing is deleted for being shared;
and running text (paragraphs, headings, quotations, cells) inside an element that the page itself marks as its article stays: a passage that two articles quote is theirs. What differencing can't
see, since it differs from page to page, is read from the markup: elements that are furniture by tag, role or class (navigation, adverts, notices, comments, forms, …), lines made of
links alone in lists, and, on pages that mark an article, what stands outside it.

Copies of a page on a host are one content with the first of their URLs; a content is aligned once, whatever the number of its copies. URLs are ranked by ranges, so that no host is one task's.

Cases: null html has an empty text; null URLs are a host of their own; a host with one content has no pair and is left to its markup; repeated rows stay; an
empty table gives an empty table; other columns, whatever their names, are not read. An unclosed quote, comment or script takes the rest of the page, as in browsers.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.lineage import global_rank

from .common import cut, drop_cut, join_checked, small_batches, sql_type

#: Share of a page's characters that makes the nearest page a version of it.
VERSIONS = 0.8
#: Bits of a table of the bit-parallel alignment.
LCS_BITS = 1 << 28

#: Elements by what they mean.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul caption select textarea".split()
)
RUNNING = set("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt td th caption figcaption li".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Never part of a main text, or only if they hold the article.
NEVER = set("head script style noscript template svg math canvas iframe object audio video map nav footer aside menu dialog select textarea button datalist xmp noembed noframes title".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars nav navbar navigation menu menus menubar "
    "submenu breadcrumb breadcrumbs footer foot topbar cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter "
    "subscribe subscription signup signin login register share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus discussion feedback "
    "widget widgets toolbar pagination pager skip copyright legal disclaimer search searchbox form contactform".split()
)
HEADER_WORDS = {"header", "masthead"}
#: An element that starts ends the open ones listed, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in BLOCKS - set(CLOSES) - {"html", "head", "body", "title", "option", "optgroup", "select", "textarea", "tbody", "thead", "tfoot", "caption"}}
SCOPES = {"p": {"table", "td", "th", "caption", "button", "article", "section", "div", "li", "blockquote", "aside", "nav", "main", "footer", "header", "form", "body"}, "li": {"ul", "ol", "menu"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}}

TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""(?i)(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style|itemprop)(?=[\s=/>"']|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ARTICLE_PROPERTIES = {"articlebody"}


class Page:
    """Elements of a page in document order and its lines."""

    def __init__(self, html: str):
        self.parent, self.tag, self.kind, self.chars = [-1], [""], [0], [0]  # kind: 1 furniture whatever it holds, 2 furniture unless it holds the article, 3 article, 4 a header
        self.lines: list[tuple[int, str, int]] = []  # element, text, characters inside links
        self.parts: list[str] = []
        self.linked = 0
        self.read(html)

    def read(self, html: str) -> None:
        open_, at, end = [0], 0, len(html)
        while at < end:
            m = TAG.search(html, at)
            data = html[at : m.start() if m else end]
            if data:
                self.text(unescape(data), open_)
            if not m:
                break
            at, name = m.end(), (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self.close(name, open_)
                continue
            if name in BLOCKS:
                self.flush(open_)
                if name in CLOSES:
                    self.imply(name, open_)
            elif name == "br":
                self.parts.append(" ")
            if name in RAW:
                stop = re.compile(rf"(?i)</{name}(?=[\s/>])[^>]*(?:>|\Z)").search(html, at)
                at = stop.end() if stop else end
            elif name not in VOID:
                self.parent.append(open_[-1])
                self.tag.append(name)
                self.kind.append(kind_of(name, m[3]))
                self.chars.append(0)
                open_.append(len(self.tag) - 1)
        self.flush(open_)
        for e in range(len(self.tag) - 1, 0, -1):
            self.chars[self.parent[e]] += self.chars[e]

    def text(self, data: str, open_: list[int]) -> None:
        self.parts.append(data)
        if any(self.tag[e] == "a" for e in open_[-6:]):
            self.linked += len("".join(data.split()))

    def flush(self, open_: list[int]) -> None:
        if self.parts:
            line = " ".join("".join(self.parts).split())
            if line:
                block = next((e for e in reversed(open_) if self.tag[e] in BLOCKS or not e), 0)
                self.lines.append((block, line, self.linked))
                self.chars[block] += len(line)
            self.parts, self.linked = [], 0

    def imply(self, name: str, open_: list[int]) -> None:
        ended, stops = CLOSES[name], SCOPES.get(name, SCOPES["p"])
        for i in range(len(open_) - 1, 0, -1):
            t = self.tag[open_[i]]
            if t in ended:
                del open_[i:]
            elif t in stops:
                return

    def close(self, name: str, open_: list[int]) -> None:
        if name in BLOCKS:
            self.flush(open_)
        for i in range(len(open_) - 1, 0, -1):
            t = self.tag[open_[i]]
            if t == name:
                del open_[i:]
                return
            if t in ("article", "main", "body", "table") and name not in ("article", "main", "body", "html", "table", "div", "section"):
                return  # a stray end tag doesn't end what is around it

    def marked(self) -> tuple[list[bool], list[bool]]:
        """For each element whether it is furniture, and whether it is inside the page's article."""
        n = len(self.tag)
        never = [False] * n
        for e in range(1, n):
            never[e] = never[self.parent[e]] or self.kind[e] == 1
        holds = [False] * n  # an article that is no furniture itself
        for e in range(n - 1, 0, -1):
            if self.kind[e] == 3 and not never[e] and self.chars[e]:
                holds[e] = True
            holds[self.parent[e]] |= holds[e]
        useful = sum(len(t) for e, t, _ in self.lines if not never[e])
        furniture, inside, header = [False] * n, [False] * n, [False] * n
        for e in range(1, n):
            p = self.parent[e]
            spared = holds[e] if holds[0] else 2 * self.chars[e] > useful
            own = self.kind[e] == 1 or (self.kind[e] in (2, 4) and not spared)
            furniture[e] = own or furniture[p]
            header[e] = furniture[e] and (self.kind[e] == 4 if not furniture[p] else header[p] and self.kind[e] not in (1, 2))
            if header[e] and inside[p] and self.tag[e] in HEADINGS:
                furniture[e] = header[e] = False  # the title in an article's own header
            inside[e] = inside[p] or (self.kind[e] == 3 and not furniture[e])
        return furniture, inside


def kind_of(name: str, attributes: str) -> int:
    if name in NEVER:
        return 1
    kind = {"article": 3, "main": 3, "form": 2, "header": 4}.get(name, 0)
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value)):
                return 1 if name not in ("html", "body") else kind
            if key == "role":
                kind = 3 if value.lower() in ("main", "article") else 2 if value.lower() in ROLES and kind != 3 else kind
            elif key == "itemprop":
                kind = 3 if value.lower() in ARTICLE_PROPERTIES else 2 if value.lower() == "comment" else kind
            elif key in ("class", "id") and name not in ("html", "body", "main"):
                words = {w.lower() for w in WORD.findall(value)}
                if words & WORDS and (kind != 3 or words & {"comment", "comments", "reply", "related", "promo", "ad", "ads", "sponsored"}):
                    kind = 2
                elif not kind and words & HEADER_WORDS:
                    kind = 4
    return kind


def read_lines(html: str) -> list[tuple[str, bool, bool]]:
    """Lines of a page: text, whether the markup lets it stay, and whether it is running text of a marked article."""
    page = Page(html)
    furniture, inside = page.marked()
    any_inside = any(inside[e] and not furniture[e] for e, _, _ in page.lines)
    out = []
    for e, line, linked in page.lines:
        only_links = linked and linked >= len(line.replace(" ", ""))
        listed = page.tag[e] in ("li", "ul", "ol", "td", "dd") or (page.tag[e] == "div" and not inside[e])
        stays = not furniture[e] and not (only_links and listed) and (inside[e] or not any_inside)
        out.append((line, bool(stays), bool(stays and inside[e] and page.tag[e] in RUNNING)))
    return out


# ---- alignment -----------------------------------------------------------------------------------------------------------------------------------


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of b, a number whose zero bits are the places of a at which the longest common subsequence of the beginnings grows."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """For each beginning of a, the length of its longest common subsequence with b."""
    v = (1 << len(a)) - 1
    for v in _rows(a, b):  # noqa: B007
        pass
    out = [0]
    for bit in bin(v | 1 << len(a))[:2:-1]:
        out.append(out[-1] + (bit == "0"))
    return out


def common(a: list[int], b: list[int], bits: int = LCS_BITS) -> list[int]:
    """The places of a that are in a longest common subsequence with b."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    at = [i for i in range(head, len(a) - tail) if a[i] in both]
    inner = _aligned([a[i] for i in at], [x for x in b[head : len(b) - tail] if x in both], bits)
    return [*range(head), *(at[i] for i in inner), *range(len(a) - tail, len(a))]


def _aligned(a: list[int], b: list[int], bits: int) -> list[int]:
    if not a or not b:
        return []
    if len(b) > 1 and len(a) * len(b) > bits:
        half = len(b) // 2
        left, right = _lengths(a, b[:half]), _lengths(a[::-1], b[half:][::-1])
        total = [x + y for x, y in zip(left, right[::-1], strict=True)]
        split = total.index(max(total))
        return _aligned(a[:split], b[:half], bits) + [split + i for i in _aligned(a[split:], b[half:], bits)]
    rows, out = list(_rows(a, b)), []
    i, j = len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            i -= 1
        elif j and not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out[::-1]


# ---- over the pages ------------------------------------------------------------------------------------------------------------------------------


def _pass(df: DataFrame, schema: str, work) -> DataFrame:
    """One Arrow pass; work takes a row's values in df's order and gives the values of the new row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = to_arrow_schema(kind)
        for batch in batches:
            cells = [[] for _ in want]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for c, x in zip(cells, work(*row), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, want, strict=True)], schema=want)

    return df.mapInArrow(run, kind)


def digest(lines: list[tuple[str, bool, bool]]) -> bytes:
    """What tells contents apart: the lines and what the markup says of them."""
    return hashlib.blake2b("\n".join(f"{s:d}{r:d}{t}" for t, s, r in lines).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def place(url: str) -> tuple[str, str]:
    """Host and path of a URL, without port, query, fragment, and a slash or file ending at the end."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", url.strip())
    rest = rest[2:] if rest.startswith("//") else rest
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, _, path = rest.partition("/")
    return re.sub(r":\d*$", "", host.rpartition("@")[2]).lower(), re.sub(r"(/|\.x?html?|/index\.\w+)$", "", path)


def contents_of(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per distinct content of a host: host, content (a digest), path (the first of its pages), hashes (of each line). The texts are not kept."""

    def work(url, html):
        import xxhash

        lines = read_lines(html or "")
        return *place(url or ""), digest(lines), [xxhash.xxh64_intdigest(t) - (1 << 63) for t, _, _ in lines]

    each = _pass(pages.select(F.col(f"`{url_col}`").cast("string").alias("c0"), F.col(f"`{html_col}`").alias("c1")), "host string, path string, content binary, hashes array<bigint>", work)
    return each.groupBy("host", "content").agg(F.min(F.struct("path", "hashes")).alias("x")).select("host", "content", "x.path", "x.hashes")


def neighbours(contents: DataFrame) -> DataFrame:
    """Per content of a host that has another: host, content, and `other`, the content whose URL is the nearest. Only keys are ranked and joined."""
    ranked = cut(global_rank(contents.select("host", "path", "content"), [F.col("host"), F.col("path"), F.col("content")], "rank"), "html-ranks")
    side = lambda n, step: ranked.select((F.col("rank") + step).alias("rank"), F.col("host").alias(f"host{n}"), F.col("content").alias(f"content{n}"), F.col("path").alias(f"path{n}"))
    both = ranked.select("rank", "host", "content", "path").join(side(1, 1), "rank", "left").join(side(2, -1), "rank", "left")
    shared = {}
    for n in (1, 2):
        own, other = F.col("path"), F.col(f"path{n}")
        folders = F.zip_with(F.split(own, "/"), F.split(other, "/"), lambda a, b: F.coalesce(a == b, F.lit(False)))
        lead = F.array_position(folders, False)
        same = F.col(f"host{n}").eqNullSafe(F.col("host")) & F.col(f"content{n}").isNotNull()
        shared[n] = F.when(same, F.when(lead == 0, F.size(folders)).otherwise(lead - 1))
    which = F.when(shared[1].isNotNull() & (shared[2].isNull() | (shared[1] >= shared[2])), F.col("content1")).when(shared[2].isNotNull(), F.col("content2"))
    return both.select("host", "content", which.alias("other")).where("other IS NOT NULL")


def shared_lines(contents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: host, content and `shared`, the numbers of its lines (from 0) that the neighbour shares, in 4 bytes each."""
    mine, its = contents.select("host", "content", "hashes"), contents.select("host", F.col("content").alias("other"), F.col("hashes").alias("others"))
    both = pairs.join(mine, ["host", "content"]).join(its, ["host", "other"]).select("host", "content", "hashes", "others")
    return _pass(both, "host string, content binary, shared binary", lambda host, content, a, b: (host, content, array("i", common(a, b)).tobytes()))


def main_lines(lines: list[tuple[int, bool, str]], shared: set[int]) -> tuple[list[str], int]:
    """The lines that stay of (number, running, text), given the numbers of those that the neighbour shares; and how many were deleted."""
    size = sum(len(t) for *_, t in lines)
    if sum(len(t) for i, _, t in lines if i in shared) >= VERSIONS * size:
        return [t for *_, t in lines], 0
    out = [t for i, running, t in lines if running or i not in shared]
    return out, len(lines) - len(out)


def pack(lines: list[tuple[int, bool, str]]) -> bytes:
    """Lines for the way to the join, compressed: their numbers (running text below zero), then their texts; no line has a line feed in it."""
    head = ",".join(str(-i - 1 if running else i) for i, running, _ in lines)
    return zstandard.compress("\n".join([head, *(t for *_, t in lines)]).encode("utf-8", "surrogatepass"))


def unpack(packed: bytes) -> list[tuple[int, bool, str]]:
    head, *texts = zstandard.decompress(packed).decode("utf-8", "surrogatepass").split("\n")
    return [(-i - 1, True, t) if i < 0 else (i, False, t) for i, t in zip(map(int, head.split(",") if head else ()), texts, strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars (code points of the text), n_lines, n_shared (lines deleted because the nearest page has them).

    Pages are read twice: first for their hashes, which are all that is ranked, paired and aligned, then for the lines that the markup lets stay, which meet the
    numbers of the shared ones. Where these are few (join_checked) no text is shuffled.
    """
    contents = cut(contents_of(pages, url_col, html_col), "html-contents")
    pairs = cut(neighbours(contents), "html-pairs")
    shared = cut(shared_lines(contents, pairs), "html-shared")
    drop_cut(contents, pairs)
    ids = f"page_id {sql_type(pages, id_col)}, url {sql_type(pages, url_col)}"

    def work(i, url, html):
        lines = read_lines(html or "")
        return i, url, place("" if url is None else str(url))[0], digest(lines), pack([(n, r, t) for n, (t, s, r) in enumerate(lines) if s])

    def finish(i, url, packed, numbers):
        kept, gone = main_lines(unpack(packed), set(array("i", numbers or b"")))
        text = "\n\n".join(kept)
        return i, url, text, len(text), len(kept), gone

    rows = _pass(pages.select(*(F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate((id_col, url_col, html_col)))), f"{ids}, host string, content binary, packed binary", work)
    joined = join_checked(rows, shared, ["host", "content"], "left", ["shared"]).select("page_id", "url", "packed", "shared")
    return _pass(joined, f"{ids}, text string, n_chars bigint, n_lines bigint, n_shared bigint", finish)
