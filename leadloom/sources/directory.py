"""Pages of a project directory to candidates: cards of a browse page, details of a project's page, and rows of a search engine for either."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.lineage import spread
from ..functions.text import clean_person_name, first_present, humanize_slug, present, squeeze, text
from ..functions.urls import host, path

VOID = {"br", "img", "meta", "link", "input", "hr"}
HOLDERS = ("li", "article", "div")
CARDS = "page_id bigint, page_url string, pos int, href string, anchor string, lines array<string>, image string"
DETAIL = "url string, meta map<string,string>, image string, parts array<struct<mark:string,text:string,content:string,hrefs:array<string>,names:array<string>>>, hrefs array<string>"

#: The same for Arrow; the pages that are Python objects at one time, whatever the size of a batch.
STRINGS = pa.list_(pa.string())
CARDS_ARROW = pa.schema([("page_id", pa.int64()), ("page_url", pa.string()), ("pos", pa.int32()), ("href", pa.string()), ("anchor", pa.string()), ("lines", STRINGS), ("image", pa.string())])
PART = pa.struct([("mark", pa.string()), ("text", pa.string()), ("content", pa.string()), ("hrefs", STRINGS), ("names", STRINGS)])
DETAIL_ARROW = pa.schema([("url", pa.string()), ("meta", pa.map_(pa.string(), pa.string())), ("image", pa.string()), ("parts", pa.list_(PART)), ("hrefs", STRINGS)])
SLICE = 100


class Tree(HTMLParser):
    """Calls back with each element's text, links and first image when it ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.done: list[dict] = []
        self.feed_root()

    def feed_root(self) -> None:
        self.open.append({"tag": "", "attrs": {}, "lines": [], "hrefs": [], "image": "", "cards": []})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        image = a.get("src") or a.get("data-src") or "" if tag == "img" else ""
        for e in self.open:
            e["image"] = e["image"] or image
            if tag == "a" and a.get("href"):
                e["hrefs"].append(a["href"].strip())
        node = {"tag": tag, "attrs": a, "lines": [], "hrefs": [a["href"].strip()] if tag == "a" and a.get("href") else [], "image": image, "cards": [], "within": [e["attrs"].get("class", "") for e in self.open]}
        if tag in VOID:
            self.done.append(node)
        else:
            self.open.append(node)

    def handle_data(self, data: str) -> None:
        line = " ".join(data.split())
        if line:
            for e in self.open:
                e["lines"].append(line)

    def handle_endtag(self, tag: str) -> None:
        if any(e["tag"] == tag for e in self.open[1:]):
            while True:
                node = self.open.pop()
                self.done.append(node)
                if node["tag"] == "a" and node["hrefs"]:
                    holder = next((e for t in HOLDERS for e in reversed(self.open) if e["tag"] == t), self.open[-1])
                    node["holder"] = holder
                if node["tag"] == tag:
                    return

    def elements(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        self.done += reversed(self.open)
        return self.done


def absolute(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return ""


def project_links(page_id: int, url: str, html: str) -> list[tuple]:
    out = []
    for e in Tree().elements(html):
        if e["tag"] == "a" and e["hrefs"]:
            holder = e.get("holder", e)
            out.append((page_id, url, len(out), absolute(url, e["hrefs"][0]), " ".join(e["lines"]), holder["lines"], absolute(url, holder["image"]) if holder["image"] else ""))
    return out


def project_parts(url: str, html: str) -> tuple:
    """Descriptions in meta elements, and every element whose class carries a mark of fixed.PROJECT_MARKS."""
    meta, parts, hrefs, image = {}, [], [], ""
    for e in Tree().elements(html):
        a = e["attrs"]
        if e["tag"] == "meta" and (a.get("property") or a.get("name")):
            meta.setdefault(a.get("property") or a["name"], a.get("content", ""))
        image = image or e["image"] if e["tag"] == "img" else image
        if e["tag"] == "a" and e["hrefs"]:
            hrefs.append(absolute(url, e["hrefs"][0]))
        own, around = a.get("class", "").split(), {c for x in e.get("within", []) for c in x.split()}
        marks = [m for m in fixed.PROJECT_MARKS if m in own] + [f"{m} {e['tag']}" for m in fixed.PROJECT_MARKS if m in around and e["tag"] in ("a", "p")]
        for m in marks:
            parts.append({"mark": m, "text": " ".join(e["lines"]), "content": a.get("content", ""), "hrefs": [absolute(url, h) for h in e["hrefs"]], "names": own})
    return url, meta, absolute(url, meta.get("og:image") or image) if meta.get("og:image") or image else "", parts, hrefs


def by_slices(read: Callable[[dict], Iterator[tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function that reads SLICE pages at a time: `read` gives the rows of a slice's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                rows = list(read(b.slice(i, SLICE).to_pydict()))
                cells = zip(*rows, strict=True) if rows else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

    return run


def cards_of(part: dict) -> Iterator[tuple]:
    for i, u, h in zip(part["page_id"], part["url"], part["html"], strict=True):
        yield from project_links(i, u or "", h or "")


def details_of(part: dict) -> Iterator[tuple]:
    for u, h in zip(part["url"], part["html"], strict=True):
        url, meta, *rest = project_parts(u or "", h or "")
        yield url, list(meta.items()), *rest


def parse_cards(pages: DataFrame) -> DataFrame:
    """Links of pages (page_id, url, html) with the lines and the first image of what holds them; see CARDS."""
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return spread(rows).mapInArrow(by_slices(cards_of, CARDS_ARROW), CARDS)


def parse_details(pages: DataFrame) -> DataFrame:
    """Marked parts of project pages (url, html); see DETAIL."""
    return spread(pages.select("url", "html")).mapInArrow(by_slices(details_of, DETAIL_ARROW), DETAIL)


def project_url(url: Column | str) -> Column:
    """A project's URL without query and fragment, NULL for other URLs."""
    scheme = F.regexp_extract(text(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return F.when((scheme != "") & path(url).rlike(fixed.PROJECT_PATH), F.concat(scheme, path(url)))


def directory_cards(pages: DataFrame) -> DataFrame:
    """Browse pages (page_id, url, html) as candidates (page_id, project_url, title, author_name, snippet, cover_image_url, confidence), the first of each project of a page; .78 with an author, else .62."""
    links = parse_cards(pages).withColumn("project_url", project_url("href")).where("project_url is not null")
    links = links.withColumn("title", F.left(squeeze(text("anchor"), r"\s+"), F.lit(500))).where(present("title") & (F.lower("title") != "more"))
    first = links.groupBy("page_id", "project_url").agg(F.min_by(F.struct("title", "lines", "image"), "pos").alias("c")).select("page_id", "project_url", "c.*")
    line = F.try_element_at(F.filter("lines", lambda x: x.rlike(r"(?i)^by\s+.+$")), F.lit(1))
    inside = F.regexp_extract(F.array_join("lines", "\n"), r"(?i)\bby\s+([^\n]+)", 1)
    author = F.btrim(first_present(F.regexp_replace(line, r"(?i)^by\s+", ""), inside), F.lit(" ."))
    rows = first.withColumn("author_name", F.left(author, F.lit(255)))
    other = F.filter("lines", lambda x: ~F.lower(x).isin("more") & (F.lower(x) != F.lower(F.col("title"))) & (~present("author_name") | (F.lower(x) != F.lower(F.concat(F.lit("by "), F.col("author_name"))))))
    return rows.select("page_id", "project_url", "title", "author_name", F.left(F.array_join(F.slice(other, 1, 4), " "), F.lit(1000)).alias("snippet"), F.col("image").alias("cover_image_url"), F.when(present("author_name"), 0.78).otherwise(0.62).alias("confidence"))


def project_details(pages: DataFrame) -> DataFrame:
    """Project pages (url, html) as (project_url, title, author_name, detail_text, cover_image_url, profile_urls, author_urls)."""
    d = parse_details(pages)
    of = lambda *marks: F.filter("parts", lambda p: p["mark"].isin(*marks))
    one = lambda parts, f: text(F.try_element_at(F.transform(parts, lambda p: p[f]), F.lit(1)))
    title = first_present(one(of("public-project-title"), "content"), F.when(F.size(of("public-project-title")) == 0, F.col("meta")["og:title"]), one(of("public-project-title"), "text"))
    title = F.trim(F.regexp_replace(squeeze(title, r"\s+"), fixed.PROJECT_TITLE_TAIL, ""))
    credit = clean_person_name(F.regexp_replace(one(of("public-project-credit"), "text"), r"(?i),\s*author.*$", ""))
    link = one(F.filter("parts", lambda p: ((p["mark"] == "user-profile-card a") & F.array_contains(p["names"], "name")) | (p["mark"] == "public-project-credit a")), "text")
    told = F.array_join(F.filter(F.transform(of(*fixed.PROJECT_TEXTS), lambda p: p["text"]), lambda x: x != ""), " ")
    about = F.left(squeeze(first_present(told, F.col("meta")["description"]), r"\s+"), F.lit(3000))
    profiles = F.array_distinct(F.filter(F.flatten(F.transform(of("user-profile-card a", "public-project-credit a"), lambda p: p["hrefs"])), lambda u: path(u).startswith("/profile/")))
    scoped = F.flatten(F.transform(of("user-profile-social", "public-project-credit", "profile-social"), lambda p: p["hrefs"]))
    links = F.array_distinct(F.filter(F.when(F.size(scoped) > 0, scoped).otherwise(F.col("hrefs")), lambda u: u.rlike("^https?://")))
    social = "|".join(x.replace(".", r"\.") for x in fixed.SOCIAL_HOSTS)
    outside = F.filter(links, lambda u: (host(u) != "") & (host(u) != host("url")) & ~F.lower(u).rlike(social))
    return d.select(F.coalesce(project_url("url"), F.col("url")).alias("project_url"), title.alias("title"), first_present(credit, clean_person_name(link)).alias("author_name"), about.alias("detail_text"), text("image").alias("cover_image_url"), profiles.alias("profile_urls"), outside.alias("author_urls"))


def merge_details(cards: DataFrame, details: DataFrame) -> DataFrame:
    """Cards with their details over them: title and author where the detail has them, a longer text, a cover where none is."""
    once = details.groupBy("project_url").agg(F.min(F.struct(*(F.col(c) for c in ("title", "author_name", "detail_text", "cover_image_url")))).alias("_d"))
    j = cards.join(once, "project_url", "left")
    d = F.col("_d")
    longer = F.char_length(text(d["detail_text"])) > F.char_length(text("snippet"))
    over = {
        "title": first_present(F.left(d["title"], F.lit(500)), "title"), "author_name": first_present(F.left(d["author_name"], F.lit(255)), "author_name"),
        "snippet": F.when(longer, F.left(d["detail_text"], F.lit(1000))).otherwise(F.col("snippet")), "cover_image_url": first_present("cover_image_url", d["cover_image_url"]),
    }
    return j.select(*(over[c].alias(c) if c in over else F.col(c) for c in cards.columns))


def directory_results(results: DataFrame, site: str) -> DataFrame:
    """Search results (result_id, title, snippet, url) of the directory's site that are projects, in the form of cards; .68 with an author, else .5."""
    rows = results.withColumn("project_url", project_url("url")).where(F.col("project_url").isNotNull() & (host("url").endswith(site)))
    brand = site.split(".")[0]
    bare = F.trim(F.regexp_replace(squeeze(text("title"), r"\s+"), rf"(?i)\s*[-|:]\s*{brand}.*$", ""))
    title = F.when((bare == "") | (F.lower(bare) == brand), humanize_slug("project_url")).otherwise(bare)
    words = squeeze(F.concat_ws(" ", text("title"), text("snippet")), r"\s+")
    named = first_present(*(F.regexp_extract(words, p, 1) for p in fixed.PROJECT_AUTHORS))
    rows = rows.withColumns({"_t": F.left(title, F.lit(500)), "author_name": F.left(clean_person_name(named), F.lit(255))}).where(present("_t"))
    return rows.select("result_id", "project_url", F.col("_t").alias("title"), "author_name", F.left(squeeze(text("snippet"), r"\s+"), F.lit(1000)).alias("snippet"), F.when(present("author_name"), 0.68).otherwise(0.5).alias("confidence"))


__all__ = ["directory_cards", "directory_results", "merge_details", "parse_cards", "parse_details", "project_details", "project_url"]
