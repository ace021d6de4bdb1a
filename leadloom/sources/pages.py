"""Raw pages to tables of facts, links, forms and hidden contacts: one Arrow pass parses each page once; all rules after it are columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.contacts import deobfuscate_email, e164, extract_emails, extract_phones, obfuscated_emails, usable_email, xor_decode
from ..functions.lineage import spread
from ..functions.text import alternation, bound, clean_person_name, first_present, present, text, valid_person_name
from ..functions.trust import named_in_text, run_of, site_owned
from ..functions.urls import host, path, registered_domain_of_url

SKIPPED = {"script", "style", "noscript", "svg"}
FIELDS = {"input", "textarea", "select"}
WATCHED = ("data-email", "data-contact", "data-phone", "aria-label", "title", "content")
SCHEMA = (
    "page_id bigint, url string, page_text string, title string, h1 string, h2 string, description string, links array<struct<href:string,anchor:string>>, "
    "forms array<struct<action:string,ident:string,fields:string,has_message:boolean>>, attributes array<struct<kind:string,value:string>>"
)
#: SCHEMA for Arrow; the pages that are Python objects at one time, whatever the size of a batch.
_items = lambda *names, **types: pa.list_(pa.struct([(n, types.get(n, pa.string())) for n in names]))
ARROW = pa.schema(
    [("page_id", pa.int64()), *((n, pa.string()) for n in ("url", "page_text", "title", "h1", "h2", "description")), ("links", _items("href", "anchor")), ("forms", _items("action", "ident", "fields", "has_message", has_message=pa.bool_())), ("attributes", _items("kind", "value"))]
)
SLICE = 100


class Reader(HTMLParser):
    """Collects a page's text, headings, links, forms and attributes that may hide a contact."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.words, self.open, self.caught = [], [], {"title": [], "h1": [], "h2": [], "a": []}
        self.description, self.links, self.forms, self.attributes, self.href = "", [], [], [], None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag not in {"br", "img", "meta", "link", "input", "hr"}:
            self.open.append(tag)
        if tag == "meta" and not self.description and "description" in (a.get("name", "").lower(), a.get("property", "").lower().removeprefix("og:")):
            self.description = a.get("content", "").strip()
        href = a.get("href", "")
        if tag == "a" and href:
            self.href, self.caught["a"] = href.strip(), []
        if href.lower().startswith(("mailto:", "tel:")):
            kind, _, rest = href.partition(":")
            self.attributes.append((kind.lower(), unquote(rest.split("?", 1)[0])))
        coded = a.get("data-cfemail") or (href.split("#", 1)[1] if "/cdn-cgi/l/email-protection#" in href else "")
        if coded:
            self.attributes.append(("xor", coded))
        self.attributes += [(k, a[k]) for k in WATCHED if a.get(k)]
        if tag == "form":
            self.forms.append([a.get("action", "").strip(), f"{a.get('id', '')} {a.get('class', '')}", [], False])
        elif tag in FIELDS and "form" in self.open and self.forms:
            self.forms[-1][2].append(a.get("name") or a.get("id") or a.get("placeholder") or "")
            self.forms[-1][3] |= tag == "textarea"

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.href is not None:
            self.links.append((self.href, " ".join(" ".join(self.caught["a"]).split())))
            self.href = None
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if SKIPPED.intersection(self.open):
            return
        if "title" in self.open:
            self.caught["title"].append(data)
        self.words.append(data)
        for tag in ("h1", "h2"):
            if tag in self.open:
                self.caught[tag].append(data)
        if self.href is not None:
            self.caught["a"].append(data)


def read_page(page_id: int, url: str, html: str) -> tuple:
    r = Reader()
    r.feed(html)
    r.close()
    squeeze = lambda parts: " ".join(" ".join(parts).split())
    for m in re.finditer(r'(?i)"(?:email|contactEmail)"\s*:\s*"([^"@\s]+@[^"\s]+)"', unescape(html)):
        r.attributes.append(("json", m.group(1)))
    links, seen = [], set()
    for href, anchor in r.links:
        try:
            full = urljoin(url, href)
        except ValueError:
            continue
        if full.startswith(("http://", "https://")) and full not in seen:
            seen.add(full)
            links.append((full, anchor))
    forms = [(urljoin(url, a) if a else url, i, " ".join(f), m) for a, i, f, m in r.forms]
    return page_id, url, squeeze(r.words), squeeze(r.caught["title"]), squeeze(r.caught["h1"]), squeeze(r.caught["h2"]), r.description, links, forms, r.attributes


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (page_id, url, html) as batches of SCHEMA, of SLICE pages at most."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            part = b.slice(i, SLICE).to_pydict()
            rows = [read_page(n, u or "", h or "") for n, u, h in zip(part["page_id"], part["url"], part["html"], strict=True)]
            cells = [list(c) for c in zip(*rows, strict=True)]
            for c, keys in ((7, ("href", "anchor")), (8, ("action", "ident", "fields", "has_message")), (9, ("kind", "value"))):
                cells[c] = [[dict(zip(keys, x, strict=True)) for x in cell] for cell in cells[c]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, ARROW, strict=True)], schema=ARROW)


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages (page_id, url, html) parsed once; see SCHEMA."""
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.col(html).alias("html")).mapInArrow(read_batches, SCHEMA)


def page_facts(parsed: DataFrame) -> DataFrame:
    """Visible text, title (else first heading), description."""
    return parsed.select("page_id", "url", "page_text", first_present("title", "h1").alias("title"), text("description").alias("description"))


def page_links(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", "url", F.posexplode("links").alias("pos", "l")).select("page_id", "url", "pos", F.col("l.href").alias("href"), F.col("l.anchor").alias("anchor"))


def social_platform(url: Column | str) -> Column:
    """The platform that a link belongs to, else NULL."""
    kind = F.lit(None).cast("string")
    for part, name in reversed(list(fixed.SOCIAL_HOSTS.items())):
        kind = F.when(F.contains(F.lower(url), F.lit(part)), name).otherwise(kind)
    return kind


def social_links(links: DataFrame) -> DataFrame:
    """Per page a map of platform to its first link."""
    first = links.withColumn("field", F.concat(social_platform("href"), F.lit("_url"))).where("field is not null").groupBy("page_id", "field").agg(F.min_by("href", "pos").alias("href"))
    return first.groupBy("page_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "href")))).alias("socials"))


CONTACT_INTENT = r"(?i)(contact|about|media|press|booking|visit|speak|appear|event|hire|work-with|get-in-touch|reach|email|agent|represent|publicit|school|media-?kit|press-?kit|faq)"
FILES = r"(?i)\.(pdf|jpe?g|png|gif|zip|docx?|xlsx?|mp3|mp4|svg|webp|css|js)$"


def contact_links(links: DataFrame, most: int = 12) -> DataFrame:
    """The first same-site links of contact intent in path or anchor, no files, no home page."""
    target, own = host("href"), F.regexp_replace(host("url"), r"^www\.", "")
    same = (target == host("url")) | target.endswith(F.concat(F.lit("."), own))
    where = F.btrim(path("href"), F.lit("/"))
    good = links.where(same & (where != "") & ~where.rlike(FILES) & (where.rlike(CONTACT_INTENT) | F.col("anchor").rlike(CONTACT_INTENT)))
    return good.groupBy("page_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "href"))), 1, most).alias("x")).select("page_id", F.transform("x", lambda x: x["href"]).alias("contact_links"))


def external_links(links: DataFrame, most: int = 10) -> DataFrame:
    """The first links to other sites that are no social platform."""
    social = F.lower("href").rlike("|".join(re.escape(x) for x in fixed.SOCIAL_HOSTS))
    good = links.where((registered_domain_of_url("href") != registered_domain_of_url("url")) & ~social)
    return good.groupBy("page_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "href"))), 1, most), lambda x: x["href"]).alias("external_links"))


ACTION_HINT = r"(?i)(contact|enquir|inquir|message|get-in-touch|reach|write-to|mail|form)"
FIELD_HINT = r"(?i)(email|e-mail|message|comment|enquir|inquir|subject|your-name|fullname)"
OTHER_FORM = r"(?i)(search|login|signin|sign-in|cart|checkout|subscribe|newsletter|comment-post|wp-login|add-to-cart)"


def contact_forms(parsed: DataFrame) -> DataFrame:
    """Forms that look like a way to make contact: action, kind, field names; one per action."""
    f = parsed.select("page_id", F.posexplode("forms").alias("pos", "f")).select("page_id", "pos", "f.*").where(F.col("action").rlike("^https?://"))
    other = F.col("action").rlike(OTHER_FORM) | F.col("ident").rlike(OTHER_FORM)
    explicit = F.col("action").rlike(ACTION_HINT) | F.col("ident").rlike(ACTION_HINT)
    good = f.where(~other & (explicit | (F.col("fields").rlike(FIELD_HINT) & F.col("has_message"))))
    kind = F.when(explicit, "contact_form").otherwise("generic_form")
    names = F.slice(F.filter(F.split("fields", " "), lambda x: x != ""), 1, 10)
    first = F.min_by(F.struct(kind.alias("kind"), names.alias("fields")), "pos").alias("x")
    return good.withColumn("_a", F.substring_index("action", "#", 1)).groupBy("page_id", F.col("_a").alias("action")).agg(first).select("page_id", "action", "x.*")


def hidden_contacts(parsed: DataFrame) -> DataFrame:
    """(page_id, field, value): contacts in links, attributes, coded payloads, structured data and prose, each validated."""
    a = parsed.select("page_id", F.explode("attributes").alias("a")).select("page_id", "a.*")
    decoded = F.when(F.col("kind") == "xor", xor_decode("value")).otherwise(F.col("value"))
    mails = a.where("kind <> 'tel'").select("page_id", F.lit("email").alias("field"), F.explode(extract_emails(decoded)).alias("value"))
    phones = a.where(F.col("kind").isin("tel", "data-phone", "data-contact")).select("page_id", F.lit("phone").alias("field"), e164("value").alias("value")).where("value is not null")
    prose = parsed.select("page_id", F.lit("email").alias("field"), F.explode(F.array_union(extract_emails("page_text"), obfuscated_emails("page_text"))).alias("value"))
    numbers = parsed.select("page_id", F.lit("phone").alias("field"), F.explode(extract_phones("page_text")).alias("value"))
    return mails.unionByName(phones).unionByName(prose).unionByName(numbers).distinct()


def author_from_page(h1: Column | str, h2: Column | str, title: Column | str, result_title: Column | str) -> Column:
    """The first usable name of one to five words among the headings, page title and result title."""
    noise = r"(?i)\b(home|welcome to|official (?:web)?site(?: of)?|author|illustrator|books by|about|contact|website)\b|[|–—-].*$"

    def name(c: Column | str) -> Column:
        v = clean_person_name(F.trim(F.regexp_replace(F.regexp_replace(text(c), noise, " "), r"\s+", " ")))
        return bound(v, lambda n: F.when(valid_person_name(n) & (F.size(F.split(n, " ")) <= 5), n))

    return F.coalesce(name(h1), name(h2), name(title), name(result_title), F.lit(""))


def contact_match(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, title, page_text, author_name, book_title): the first mail and phone of pages that have an official page's hint in URL or title, name the author, and are on the author's site or under their name.

    Pages of blocked domains and unusable addresses are left out; a page without mail and phone gives no row. Confidence is .78 with the start of the book's title (24 characters, joined) in the text, else .68.
    """
    domain = F.regexp_replace(host("url"), r"^www\.", "")
    blocked = domain.isin(fixed.CONTACT_BLOCKED_DOMAINS) | domain.rlike(alternation(fixed.CONTACT_BLOCKED_PARTS))
    hinted = F.lower(F.concat_ws(" ", text("url"), text("title"))).rlike(alternation(fixed.OFFICIAL_PAGE_HINTS))
    good = pages.where(~blocked & hinted & site_owned("author_name", "url", "title") & named_in_text("author_name", "url", "title", "page_text"))
    stem = F.left(run_of("book_title"), F.lit(24))
    confidence = F.when((stem != "") & F.contains(run_of("page_text"), stem), 0.78).otherwise(0.68)
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    mails = F.filter(extract_emails("page_text"), lambda m: ~F.lower(m).rlike(alternation(fixed.CONTACT_UNUSABLE)))
    out = good.select("page_id", "url", first(mails).alias("email"), first(extract_phones("page_text")).alias("phone"), confidence.alias("confidence"))
    return out.where(present("email") | present("phone"))


def page_contact_record(pages: DataFrame) -> DataFrame:
    """pages (page_id, website, url, page_text, links array<struct<href,anchor>>): the first usable mail and phone and the first link of each social platform, with evidence.

    Confidence is .65 with anything found, else .25 and a warning; evidence carries .55 for phones and .7 for the rest. `socials` is a map.
    """
    mails = F.filter(F.array_distinct(F.transform(extract_emails("page_text"), lambda m: deobfuscate_email(m))), lambda m: usable_email(m))
    rows = pages.withColumns({"_mails": mails, "_phones": extract_phones("page_text"), "_links": F.coalesce(F.transform("links", lambda x: x["href"]), F.array().cast("array<string>"))})
    first_of = lambda name: F.try_element_at(F.filter("_links", lambda u: social_platform(u) == name), F.lit(1))
    of = {f"{name}_url": first_of(name) for name in dict.fromkeys(fixed.SOCIAL_HOSTS.values())}
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in of.items())), lambda x: x["value"].isNotNull())
    rows = rows.withColumns({"public_email": F.try_element_at("_mails", F.lit(1)), "public_phone": F.try_element_at("_phones", F.lit(1)), "socials": F.map_from_entries(entries)})
    own = F.array(F.struct(F.lit("public_email").alias("key"), F.col("public_email").alias("value")), F.struct(F.lit("public_phone").alias("key"), F.col("public_phone").alias("value")))
    found = F.filter(F.concat(own, F.map_entries("socials")), lambda x: x["value"].isNotNull())
    rows = rows.withColumn("_found", found)
    evidence = F.transform("_found", lambda x: F.struct(x["key"].alias("field"), x["value"].alias("value"), F.col("url").alias("source_url"), F.when(x["key"] == "public_phone", 0.55).otherwise(0.7).alias("confidence")))
    some = F.size("_found") > 0
    warning = F.when(~some, F.concat(F.lit("No public contact data found on "), host("website"), F.lit(".")))
    page = F.when(F.contains(F.lower("url"), F.lit("contact")), F.col("url"))
    return rows.select("page_id", F.col("website").alias("canonical_website"), page.alias("contact_page_url"), "public_email", "public_phone", "socials", F.when(some, 0.65).otherwise(0.25).alias("confidence"), F.array_compact(F.array(warning)).alias("warnings"), evidence.alias("evidence"))


def site_lead_rows(pages: DataFrame, listing_links: DataFrame) -> DataFrame:
    """Pages of a site (site, pos, url, page_text, h1, h2, title) with its listing links (site, pos, href): one row per author and listing, from the first page with a contact; at most two listings."""
    from ..functions.scores import topic_signal
    from ..functions.urls import listing_id

    facts = spread(pages.select("site", "pos", "url", "page_text", "h1", "h2", "title")).withColumns({"mail": F.try_element_at(extract_emails("page_text"), F.lit(1)), "phone": F.try_element_at(extract_phones("page_text"), F.lit(1)), "name": F.nullif(author_from_page("h1", "h2", "title", F.lit("")), F.lit(""))})
    has = F.col("mail").isNotNull() | F.col("phone").isNotNull()
    of_site = facts.groupBy("site").agg(
        F.min_by("name", F.when(F.col("name").isNotNull(), F.col("pos"))).alias("author_name"), F.min_by(F.struct("url", "mail", "phone"), F.when(has, F.col("pos"))).alias("c"),
        F.bool_or(topic_signal("title", "page_text")).alias("topic"), F.array_join(F.transform(F.array_sort(F.collect_set("url")), lambda u: u), "; ").alias("all_source_urls"),
    )
    codes = listing_links.withColumn("asin", listing_id("href")).where("asin is not null").groupBy("site", "asin").agg(F.min("pos").alias("pos"), F.min_by("href", "pos").alias("amazon_book_url"))
    two = codes.groupBy("site").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "asin", "amazon_book_url"))), 1, 2).alias("l"))
    rows = of_site.where(F.col("c").isNotNull() & F.col("topic") & F.col("author_name").isNotNull()).join(two, "site").select("*", F.explode("l").alias("x"))
    return rows.select("site", "author_name", "x.asin", "x.amazon_book_url", text("c.mail").alias("public_email"), text("c.phone").alias("public_phone"), F.col("c.url").alias("contact_source_url"), "all_source_urls")


__all__ = ["SCHEMA", "author_from_page", "contact_forms", "contact_links", "contact_match", "external_links", "hidden_contacts", "page_contact_record", "page_facts", "page_links", "parse_pages", "site_lead_rows", "social_links"]
